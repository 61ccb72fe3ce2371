"""The link relation over streams of hyperedges."""
