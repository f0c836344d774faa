"""DataFrame-to-DataFrame operators; each is lazy and takes its columns as parameters."""
