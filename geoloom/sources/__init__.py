"""Sources and the derived tables of the tests."""
