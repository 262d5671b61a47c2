"""Fleet analytics on Spark: driver features, eligibility, coverage and segmentation."""

__version__ = "0.1.0"
