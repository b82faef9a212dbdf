"""weftwork: an entity-resolution and corpus-processing engine on Spark DataFrames."""
