"""Table-valued functions: metrics, profiles and two-source fidelity statistics."""
