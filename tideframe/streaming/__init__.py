"""streaming of the tideframe engine."""
