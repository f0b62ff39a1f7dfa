"""quern: a Spark-native analytics engine for labelled graphs stored as (h, r, t) rows."""
