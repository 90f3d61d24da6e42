"""Errors of the engine; their messages are stable."""


class EngineError(Exception):
    message = "engine error"

    def __init__(self, detail: str = ""):
        super().__init__(f"{self.message}: {detail}" if detail else self.message)


def _kind(name: str, message: str) -> type[EngineError]:
    return type(name, (EngineError,), {"message": message, "__module__": __name__})


CollectionExists = _kind("CollectionExists", "collection already exists")
CollectionNotFound = _kind("CollectionNotFound", "collection not found")
DocumentNotFound = _kind("DocumentNotFound", "document not found")
DocumentExists = _kind("DocumentExists", "document already exists")
NoResultsFound = _kind("NoResultsFound", "no satisfied results found")
IndexNotFound = _kind("IndexNotFound", "index not found")
InvalidDimension = _kind("InvalidDimension", "invalid vector dimension")
FailedToCreateIndex = _kind("FailedToCreateIndex", "failed to create index")
FailedToLoadIndex = _kind("FailedToLoadIndex", "failed to load index")
UnsupportedIndexType = _kind("UnsupportedIndexType", "unsupported index type")
MismatchedKeysAndValues = _kind("MismatchedKeysAndValues", "keys and values length mismatch")
InvalidParameter = _kind("InvalidParameter", "invalid parameter")
EmptyParameter = _kind("EmptyParameter", "empty parameter")
