"""Credit-risk analytics on Spark DataFrames.

Every operator is a plain function ``(DataFrame, params) -> DataFrame`` or a
``fit(DataFrame) -> plan`` / ``apply(DataFrame, plan)`` pair whose plan holds only
small Python values.
"""
