"""Privacy-incident analytics on Spark: labelling, features, rules, scores, evaluation and interpretable models as DataFrame operators."""
