"""marketframe: dated market panels as Spark tables and DataFrame operators."""
