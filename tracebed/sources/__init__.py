"""The binary log format and its data source."""
