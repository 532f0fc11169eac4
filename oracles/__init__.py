"""Independent DuckDB SQL for the driver correctness check."""
