"""Column expressions over symbol arrays and number arrays."""
