"""Queries whose doubles depend on the order of a sum in their last bits."""

ROUNDED = frozenset("""
a10_having a12_weighted_mean_coarse a13_shift_std a4_mean_median a6_grouped_means a7_mean_std_single_row
d10_monthly_author_sentiment d10_monthly_topic_of_selected_authors d10_monthly_topic_sentiment
d11_author_sentiment d11_author_sentiment_rounded d11_publication_sentiment d12_polarised_share_from_raw
d13_topic_sentiment_from_raw d13_topic_sentiment_outliers d13_topic_sentiment_outliers_band001 d14_bias_score
d14_bias_score_from_raw d14_bias_series d2_lexicon_sentiment_title d2_negation_sentiment d3_text_enrichment
g1_monthly_gap_filled g2_month_and_key g3_daily_mean g5_monthly_score_pivot g5_monthly_score_pivot_all
g6_unpivot_scores g7_transpose_summary m15_comparison_naive_bayes m1_tfidf_relational m4_naive_bayes m8_classification_report m9_weighted_scores n3_nan_to_null
s11_report_sink
""".split())
