"""What decoders raise."""

from __future__ import annotations


class Unsupported(ValueError):
    """A filter that isn't read; its name is the message."""


class Undecodable(ValueError):
    pass
