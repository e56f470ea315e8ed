"""tallyframe: table profiling, cleaning, joining, KPI and business analytics as Spark DataFrame plans."""
