"""Operators over keyed entries and versions."""
