"""Errors at the API's edge; in tables the same names stand in error_class columns."""


class PackError(Exception):
    """Base of all errors of this package."""


class CorruptPackageError(PackError, ValueError):
    """A container or frame is damaged or of another format."""


class UnsupportedCodecError(PackError, ValueError):
    """A codec, transform or method that this path does not know."""


class VerificationError(PackError, RuntimeError):
    """The restored bytes do not have the recorded hash."""


class PasswordError(PackError, ValueError):
    """Wrong password, or the ciphertext was changed."""


class BaseMismatchError(PackError, ValueError):
    """The base is not the one that a delta was made for."""


class OutputLimitError(PackError, RuntimeError):
    """The output would be larger than its cap."""


class CancelledError(RuntimeError):
    """The job was cancelled."""
