"""marketloom: search, cleaning and analysis of product and document catalogues on Spark."""
