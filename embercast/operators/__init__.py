"""DataFrame -> DataFrame operators: cleaning, features, hot-spots, statistics,
scaling/PCA, splits, exact curves and quantiles, training and scoring."""
