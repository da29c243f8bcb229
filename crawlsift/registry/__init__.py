"""Registries: what trackers, technologies, apps and structured-data types look like. Extend them with more rows."""
