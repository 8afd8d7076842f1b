"""folia: a bibliographic data engine on Spark DataFrames."""
