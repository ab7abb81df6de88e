"""Detection, interning, masking, rehydration, policy, reports and audit."""
