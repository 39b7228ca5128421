"""From syntax trees to DataFrames, and to plan text."""
