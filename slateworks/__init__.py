"""Spark-first engine for offline evaluation of user-response models and recommender policies."""
