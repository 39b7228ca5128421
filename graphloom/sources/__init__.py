"""Where graphs come from: views over tables, and versioned stores."""
