"""plans of the tideframe engine."""
