"""Configuration, registration, planning and events."""
