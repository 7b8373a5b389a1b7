"""sources of the tideframe engine."""
