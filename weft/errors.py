"""Errors of the library."""


class WeftError(Exception):
    """Base of all errors raised here."""


class ConfigError(WeftError):
    """An argument is wrong."""


class DataError(WeftError):
    """The data can't be used as asked."""


class PartitionError(WeftError):
    """A partition is used for something it isn't meant for."""


class ModelError(WeftError):
    """A model can't do what is asked."""


class WorkflowStateError(WeftError):
    """A step comes at the wrong point of a workflow."""
