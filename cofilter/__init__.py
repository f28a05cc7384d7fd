"""cofilter: collaborative-filtering analytics on Spark DataFrames.

Interaction triples in -> profile, scale, split, index -> neighbourhood
models (user-user, item-item, blend), truncated SVD and ALS -> scored pairs
and ranked lists -> RMSE and per-user Spearman. Everything runs as Spark
jobs on sparse long-form matrices; see README.md for the layout."""

__version__ = "0.1.0"
