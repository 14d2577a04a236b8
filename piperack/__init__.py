"""piperack: process-plant graph, retrieval, worksheet and audit queries as Spark DataFrame plans."""
