"""DataFrame operators keyed by scene."""
