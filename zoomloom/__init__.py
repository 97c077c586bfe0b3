"""Details-on-demand analytics on Spark: placed canvases, viewport queries, cluster pyramids and charts."""

__version__ = "0.1.0"
