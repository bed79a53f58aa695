"""An engine for high-dynamic-range imagery on DataFrames."""
