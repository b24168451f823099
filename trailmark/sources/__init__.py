"""Reading and writing event logs, rollups and documents."""
