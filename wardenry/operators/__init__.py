"""DataFrame in, DataFrame out. No operator reads a clock: ``as_of`` is a parameter."""
