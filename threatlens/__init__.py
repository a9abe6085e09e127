"""Security-log analytics on Spark: cleaning, features, rules, models, fusion, response, streams."""
