"""functions of the tideframe engine."""
