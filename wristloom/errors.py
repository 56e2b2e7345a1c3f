"""Exceptions of the library."""


class RecordingError(Exception):
    """A recording can't be processed."""


class InvalidInput(RecordingError):
    """The input is not what its format says."""


class UnsupportedFormat(RecordingError):
    """No source reads this kind of file."""


class CalibrationFailed(RecordingError):
    """Too few stationary points, or no fit within the tolerance."""


class NoData(RecordingError):
    """Nothing is left between the start and end times."""


class ModelError(RecordingError):
    """A model can't be loaded or doesn't fit the features."""
