"""Operators over streams: ``Stream -> Stream``, all lazy."""
