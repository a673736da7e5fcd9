"""DataFrame operators over events, paths and attribute rows."""
