"""Errors that callers can tell apart."""


class SpecError(ValueError):
    """A pipeline or block that doesn't say what to do."""


class TransformError(RuntimeError):
    """SQL that can't be analysed."""


class SinkError(RuntimeError):
    """Sinks that failed while others were written; ``result`` says which."""

    def __init__(self, result: dict):
        super().__init__("; ".join(f"{name}: {error}" for name, error in result["failed"].items()))
        self.result = result


class ModelError(RuntimeError):
    """A model's test that failed; ``result`` has all tests."""

    def __init__(self, message: str, result=None):
        super().__init__(message)
        self.result = result
