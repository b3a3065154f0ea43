"""Tables, mutations, interchange formats and file sources."""
