"""Errors that callers can tell apart."""


class ConfigError(ValueError):
    """A parameter, pattern or path that can't be used."""


class EncodingError(ValueError):
    """Bytes that aren't text in any encoding that may be assumed."""


class FileChanged(RuntimeError):
    """A file that changed while it was read."""
