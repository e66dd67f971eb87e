"""Collections that grow by a view with every batch of a stream."""
