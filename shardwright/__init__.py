"""Row-subset selection and training-data operators on Spark DataFrames."""
