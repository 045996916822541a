"""psephos: Spark-first analytics for survey microdata, panels, entity resolution and small econometric models."""
