"""A Spark-native engine for curating question-answer, plan-structured and text training data."""
