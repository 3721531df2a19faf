"""Records about strategies and tokens: canonical JSON, hashes, graphs, packs, custom tokens. They are small, and the driver's."""
