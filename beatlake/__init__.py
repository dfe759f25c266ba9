"""beatlake: analytics over tables of musical events, on Spark."""
