"""Errors of the engine. ``issues`` holds machine-readable tags."""


class QuillmillError(Exception):
    """Base of all library errors."""


class ConfigError(QuillmillError):
    """Options that do not fit together or name something unknown."""


class FormatError(QuillmillError):
    """Input that cannot be read as its format."""


class ValidationError(QuillmillError):
    def __init__(self, message: str, issues: tuple[str, ...] = ()):
        super().__init__(message)
        self.issues = tuple(issues)


class GenerationError(QuillmillError):
    """One chunk could not be turned into examples; a build may skip it."""


class TruncatedOutputError(GenerationError):
    """A reply was cut off and is of no use."""


class ProviderError(QuillmillError):
    """A completion provider failed; a build stops."""
