"""readmill: sequencing-read processing as Spark DataFrame operators."""
