"""milap: entity resolution, geography and evidence analytics as Spark plans."""
