"""DataFrame operators over the canonical panel."""
