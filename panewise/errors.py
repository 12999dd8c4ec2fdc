"""Errors of the library."""


class PanewiseError(Exception):
    """Base of all errors here."""


class ConfigError(PanewiseError, ValueError):
    """A configuration that cannot run."""


class UnsupportedSpaceError(ConfigError):
    """The strategy does not answer this kind of query set."""


class PartitioningError(PanewiseError, ValueError):
    """Points cannot be dealt to partitions as asked."""


class ParseError(PanewiseError, ValueError):
    """Input that is no point."""
