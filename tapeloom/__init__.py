"""tapeloom: order-level market data analytics as Spark DataFrame jobs."""
