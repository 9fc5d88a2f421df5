"""Spatial level-of-detail cubes on Spark: views, pyramids, partial-aggregate cubes and folds."""
