"""cartoflow: entity discovery and analytics over place and web tables, as DataFrame transformations."""
