"""Errors with structured context."""

from __future__ import annotations

from typing import Any


class EngineError(Exception):
    """Base of all errors; carries the operation, the file and details for reports."""

    def __init__(self, message: str, *, operation: str | None = None, file_path: str | None = None, details: dict[str, Any] | None = None) -> None:
        super().__init__(message)
        self.message, self.operation, self.file_path, self.details = message, operation, file_path, details or {}

    def as_dict(self) -> dict[str, Any]:
        """The set fields only."""
        fields = {"type": type(self).__name__, "message": self.message, "operation": self.operation, "file_path": self.file_path, "details": self.details}
        return {k: v for k, v in fields.items() if v}


class ConfigError(EngineError): ...


class HashError(EngineError): ...


class CacheError(EngineError): ...


class DuplicateError(EngineError): ...


class MediaError(EngineError): ...


class ClassifyError(EngineError): ...


class ReportError(EngineError): ...


class PipelineError(EngineError): ...


class FileOperationError(EngineError): ...


class SecurityError(EngineError): ...
