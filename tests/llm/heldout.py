"""Sentences and names of another hand than the labelled table's: about ships, libraries, sports and kitchens, with names that table has not."""

MARKED = [
    "The ferry was steered by {N} that night.", "Library card {n} is in the name of {N}.", "Goal by {N}, assist by {N}.", "Harbour master {N} can be called under {P} around the clock.", "The recipe comes from {T} {S} and serves {n}.", "Please return the book to {A} or write to {E}.", "The crew list names {N}, passport {I}.", "Our cook {N} has moved to {A}.",
    "{N} won the second set.", "Late fees: phone {P}.", "The captain's cabin belongs to {T} {S}.", "Borrower: {N}\n", "Coach: {N}\nTraining is at {time}.", "Deliver the fish to {A} before noon.", "Tickets via {E}, refunds via {P}.", "Social security number {I} of the deckhand {N}.", "With best wishes\n{N}\n{A}\n{P}", "The referee, {T} {S}, stopped the match.", "Lost: a red scarf; call {P}.", "Found by {N} under table {n}.",
    "Der Trainer {N} wohnt in {A}.", "Fragen an {E} oder {P}.", "Frau {S} leiht heute keine Bücher aus.", "Le chef {N} habite {A}.", "Questions : {E} ou {P}.", "Madame {S} ferme la cuisine.", "El capitán {N} vive en {A}.", "Preguntas a {E} o al {P}.", "La señora {S} cierra la biblioteca.",
]

PLAIN = [
    "The match ended {n} to {n} in the rain.", "Shelf {n} holds maps and atlases.", "Engine serial {z} was stamped twice.", "Boil {n} potatoes for {n} minutes.", "The {Surname} lighthouse was painted white.", "Sail number {d4} led the fleet.", "The {Place} regatta starts at {time}.", "{Surname} {firm} built the boat.", "Barcode {z} is worn off.", "Add salt, then wait.", "Der Hafen von {Place} ist klein.", "Le port est petit.", "El puerto es pequeño.", "Turn left at {Street}.", "The buoy drifted {n} miles north.",
]

GIVEN = ["Agatha", "Bartholomew", "Cordelia", "Dashiell", "Esmeralda", "Ferdinand", "Guinevere", "Horatio", "Ignatius", "Jacinta", "Leopold", "Marguerite", "Nathaniel", "Octavia", "Percival", "Quincy", "Rosalind", "Sebastian", "Theodora", "Winifred", "Zebedee", "Ludovic", "Hedwig", "Anselm"]
SURNAMES = ["Abernathy", "Blackwood", "Carrington", "Delacroix", "Eisenhower", "Featherstone", "Goldsmith", "Hawthorne", "Ingleby", "Kensington", "Lockhart", "Montague", "Nightingale", "Oppenheim", "Pemberton", "Rothschild", "Sinclair", "Thackeray", "Underhill", "Vanterpool", "Wetherby", "Yellowlees", "Zimmerli", "Ashdown"]
