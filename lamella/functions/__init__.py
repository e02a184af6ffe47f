"""Key codecs, hashes and membership filters."""
