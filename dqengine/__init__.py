"""dqengine: data-quality analytics on PySpark DataFrames."""
