"""Column builders: detection, encryption, text rules. Plain Catalyst expressions unless a module says otherwise."""
