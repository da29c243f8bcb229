"""Operators on fact tables: verdicts, detections, roll-ups, filters and export rows."""
