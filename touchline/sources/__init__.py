"""Sources and sinks: season CSV loader, season refresh, test-table adapter."""
