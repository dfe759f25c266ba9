"""Reading and writing documents, and adapters that read the star-schema tables as musical events."""
