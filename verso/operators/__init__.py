"""Operators on tables: content selection, entities, scripts, jobs, timelines, state."""
