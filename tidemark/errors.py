"""Errors that callers may want to tell apart."""


class TidemarkError(Exception):
    pass


class CaptureError(TidemarkError):
    """A capture that can't be read."""


class InvalidCapturePath(CaptureError):
    pass


class TrainingError(TidemarkError):
    pass


class InsufficientData(TrainingError):
    pass


class DetectionError(TidemarkError):
    pass


class ArtifactError(TidemarkError):
    pass
