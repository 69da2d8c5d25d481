"""Errors of the engine."""


class EngineError(Exception):
    """Base of all errors here."""


class ParseError(EngineError):
    """A file's content can't be read."""


class ModelError(EngineError):
    """An embedder or transcriber failed."""


class ModelNotLoaded(ModelError):
    """A model that isn't registered was asked for."""


class StorageError(EngineError):
    """Tables can't be read or written."""


class IndexingError(EngineError):
    """The search index can't be built or used."""


class UnsupportedFileType(EngineError):
    """No parser is registered for the extension."""


class FileNotIndexed(EngineError):
    """No file with that id or path is in the index."""


class ConcurrentChange(StorageError):
    """Two writers began from the same version of a store."""
