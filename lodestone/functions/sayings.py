"""Sentences that results must hold word for word."""

# What a withheld answer says, how versions of a process are told apart, and the lines of a rendered diagram.
REFUSAL = "Answer withheld: it cited form number(s) {} that do not appear in the process corpus. Please check the source document directly."
VARIANT = ('(This is version "', '" of "', '". ', " different versions of this process appear in the context; they are separate documents and their steps are NOT interchangeable.)")
WORKFLOW = "Approval workflow: {}."
STEPS = "Steps: {}."
ORDER = "Order of approval, first to last (each one signs after the one before it):"
ORDER_SO_FAR = "Order of approval so far, first to last (each one signs after the one before it); the route then branches:"
BRANCHES = "  After {} the route branches; who signs next depends on the value, see Routing and Approval thresholds below."
ROUTING = "Routing:"
THRESHOLDS = "Approval thresholds:"
THRESHOLD = '  - A purchase value of "{0}" requires approval by {1}. {1} approves at value: {0}.'
OTHER_THRESHOLDS = "Thresholds recorded on this page but not tied to this flow: "
