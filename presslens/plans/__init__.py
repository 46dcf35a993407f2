"""Domain jobs (D*, M*): compositions of the operators into analyses."""
