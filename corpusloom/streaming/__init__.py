"""The change log, in batch and as a stream."""
