"""operators of the tideframe engine."""
