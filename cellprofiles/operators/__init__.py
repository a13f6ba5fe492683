"""DataFrame operators; every function builds a lazy plan unless it says otherwise."""
