"""From schema to plan: Catalyst expressions or the row-level parser."""
