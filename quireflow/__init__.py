"""quireflow: a document dataflow and analytics engine on PySpark DataFrames."""
