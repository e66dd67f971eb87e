"""How a computation is run over the views of a collection."""
