"""DuckDB SQL that states the same results over the same tables; used for checking only."""
