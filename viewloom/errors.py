"""Errors by category; the category is the message's prefix."""


class EngineError(Exception):
    category = "Error"

    def __init__(self, message: str) -> None:
        super().__init__(f"[{self.category}] {message}")


class ParsingError(EngineError):
    category = "ParsingError"


class LoadGraphError(EngineError):
    category = "LoadGraphError"


class CollectionError(EngineError):
    category = "CollectionError"


class ComputationError(EngineError):
    category = "ComputationError"


class SerdeError(EngineError):
    category = "SerdeError"


class InitError(EngineError):
    category = "InitError"


class StorageError(EngineError):
    category = "StorageError"
