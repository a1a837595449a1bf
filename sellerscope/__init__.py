"""sellerscope: marketplace seller profiling and segmentation on Spark.

Every operator takes a DataFrame (plus column-name parameters) and returns a
lazy DataFrame.  Nothing is computed on the driver except scalars of bounded
size (a handful of quantile bounds, a 9x9 covariance matrix, k centroids).
"""

__version__ = "0.1.0"
