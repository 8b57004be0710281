"""An engine for line networks on Spark: polylines, junctions, pixels, labels and predictions as DataFrames."""
